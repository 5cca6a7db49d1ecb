"""The five data products, composed from the operators as one lazy plan each."""
