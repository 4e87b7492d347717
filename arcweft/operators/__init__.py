"""Operators on files, imports and graphs: parsing, name resolution, reachability, cycles, rules, lints, problems."""
