"""Column builders: text cleaning, labelling, scoring."""
