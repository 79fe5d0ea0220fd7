"""Training-data operators: ten independent modules and the queries over them."""
