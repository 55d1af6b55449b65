"""gridloom: occupancy-grid and region analytics as Spark plans."""
