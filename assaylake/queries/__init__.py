"""The registered queries. Each module has QUERIES (name -> callable) and SQL (name -> text)."""
