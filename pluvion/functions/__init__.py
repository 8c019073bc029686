"""Column expressions: dates, formats, categories, statistics, hydraulics, decisions."""
