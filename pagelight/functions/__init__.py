"""Column functions: text normalisers and tokenisers, numbers and units, question intent."""
