"""Project files as DataFrames: reading, ignore rules, compiler configuration with path aliases."""
