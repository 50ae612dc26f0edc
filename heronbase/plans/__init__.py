"""From text to plans: classification and rewriting."""
