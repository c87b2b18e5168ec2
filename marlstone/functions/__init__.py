"""Column expressions: labels, conditions, answers, scores and waveforms."""
