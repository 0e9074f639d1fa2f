"""Where spans come from and go to."""
