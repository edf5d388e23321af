"""Sources and sinks: text/JSON/log ingestion and partitioned writes."""
