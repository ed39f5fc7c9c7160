"""Sources and sinks: files, the derived transaction view, topics, and the shared work folder."""
