"""Topic landscapes over dated text collections, as functions from DataFrame to DataFrame."""
