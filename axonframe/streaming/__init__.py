"""Tick-by-tick operators: windows, leaky readouts and keyed state, in batch form and as Structured Streaming."""
