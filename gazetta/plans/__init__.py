"""Reports, pipelines and the registered queries."""
