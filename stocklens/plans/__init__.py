"""Result sets composed of operators: dashboard tables, extracts, the star schema."""
