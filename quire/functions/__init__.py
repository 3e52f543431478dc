"""Column helpers: text, boxes and the value rules that differ from SQL's."""
