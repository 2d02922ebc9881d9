"""streamatlas: a catalogue engine for live streams, written as Spark jobs over landed pages, feeds and fetch logs."""
