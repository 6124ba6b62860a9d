"""Every operator applied to the shared test tables, each next to its SQL twin."""
