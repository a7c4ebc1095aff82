"""Graph, readout, statistics, stimulus and simulation operators over DataFrames."""
