"""Reading and writing observations, products and polygons."""
