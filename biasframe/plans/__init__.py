"""biasframe.plans."""
