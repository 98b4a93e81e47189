"""Text functions: segmentation, folding, stemming, distances, highlights."""
