"""Jobs made of several operators, and the rules they share about scratch data and joins."""
