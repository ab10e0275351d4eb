"""Column expressions: names, times, states, texts and notifications of experiments."""
