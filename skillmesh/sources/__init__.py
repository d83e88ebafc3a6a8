"""File sources and sinks for postings and summaries."""
