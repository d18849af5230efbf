"""Facts, graphs and checks as DataFrame plans."""
