"""biasframe.functions."""
