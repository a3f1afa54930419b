"""DataFrame operators: discovery, index, repository, closure, rewriting, accounting, resilience, guards."""
