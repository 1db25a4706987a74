"""Reading raw tables and checking that they are complete."""
