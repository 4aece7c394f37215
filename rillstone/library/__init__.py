"""Rule programs over the star-schema tables, and the SQL that checks them."""
