"""Reading boards and tables, writing records and exports, staging shared tables."""
