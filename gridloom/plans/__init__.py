"""Choice of physical strategies from static metadata."""
