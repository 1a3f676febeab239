"""Set-at-a-time pricing operators: each takes and returns DataFrames."""
