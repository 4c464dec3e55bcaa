"""Named query plans and the SQL each one is checked against."""
