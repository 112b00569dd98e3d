"""Writers: audio, label and report forms of a table."""
