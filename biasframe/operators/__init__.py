"""biasframe.operators."""
