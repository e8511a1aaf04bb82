"""The registered queries of the grid operators, their input adapters and oracles."""
