"""Sources and sinks: media directories, container metadata, subtitles, tables, gold sets."""
