"""Plan builders shared by operators, and the queries over the driver's tables."""
