"""Column functions: no UDFs, so they stay inside whole-stage code generation."""
