"""Pipeline steps and reports built from the operators."""
