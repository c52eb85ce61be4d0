"""Part of the text-privacy engine."""
