"""biasframe.streaming."""
