"""Named queries, each with the SQL that a second engine checks it by."""
