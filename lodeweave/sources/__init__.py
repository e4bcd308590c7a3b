"""Reading files and tables, ignore rules, manifests, and writing results."""
