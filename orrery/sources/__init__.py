"""Text formats of labelled vectors and of graphs: readers are plain expressions over text lines."""
