"""Training-data operators; every module here is reached only through ``registry``."""
