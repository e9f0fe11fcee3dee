"""Driver-side plans: configuration, trust regions, candidates, acquisition, the ask/tell loop."""
