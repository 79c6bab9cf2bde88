"""Where fact rows come from and where results go."""
