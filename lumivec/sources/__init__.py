"""Sources and sinks: corpora, labelled sets, vocabularies, models."""
