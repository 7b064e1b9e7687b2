"""Where rows come from and go to: driver tables, inline values, versioned tables, writers."""
