"""DataFrame operators of the digest and trending jobs."""
