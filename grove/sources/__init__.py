"""Reading and writing of repositories."""
