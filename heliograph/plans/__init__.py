"""The query catalog: every operator over the test tables, beside SQL that gives the same rows."""
