"""Reading and writing the lakehouse's folders and tables."""
