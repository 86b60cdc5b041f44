"""Analytics for multichannel tiled images, their annotations and their documents, on Spark."""
