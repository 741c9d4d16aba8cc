"""Writers and the payload shapes they send."""
