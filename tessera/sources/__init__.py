"""Sources and sinks: model relations from tables, sorted files, framed logs, JSON lines and reports."""
