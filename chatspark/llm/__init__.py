"""Training-data operators: each module holds one operator with its own
interface; ``queries`` registers one thin named query per operator. Nothing
else in the library imports this subpackage."""
