"""Plans: where tables come from and which queries run on them."""
