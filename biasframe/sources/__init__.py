"""biasframe.sources."""
