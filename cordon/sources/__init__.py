"""Sources: corpus files, golden questions, generators, embedding providers."""
