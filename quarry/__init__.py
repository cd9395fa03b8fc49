"""quarry: document retrieval and corpus preparation as DataFrame plans."""
