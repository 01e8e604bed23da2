"""DataFrame operators: verification, confidence, review, history, serving, monitoring and extraction."""
