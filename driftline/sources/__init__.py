"""Where histories come from and where tables are kept."""
