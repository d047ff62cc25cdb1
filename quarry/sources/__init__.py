"""Sources: files and folders, archives, and the batch store."""
