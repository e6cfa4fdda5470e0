"""Training-data operators: cleaning, labelling and packing of text documents."""
