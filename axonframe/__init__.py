"""axonframe: graph extraction, experiment readout, comparative statistics and corpus operators on Spark DataFrames."""
