"""Sources and sinks: contract normalisation, JDBC and file readers, the table store and the
mapping of the generic test tables to the product's raw tables."""
