"""Column-level rules: money, percentages, labels, dates, normal tail."""
