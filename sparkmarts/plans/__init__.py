"""Plan assembly (raw -> staging -> marts) and plan inspection helpers."""
