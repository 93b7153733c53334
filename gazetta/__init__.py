"""Analytics for collections of articles, as functions from DataFrame to DataFrame."""
