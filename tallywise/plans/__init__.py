"""Studies and labelling rounds."""
