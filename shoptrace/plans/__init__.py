"""The whole analysis as one plan with shared tables."""
