"""Sources and sinks: documents, corpus files, fitted models, collections."""
