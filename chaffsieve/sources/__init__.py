"""Sources and sinks: recorded and remote responses, the classifier, log and sample files, configuration."""
