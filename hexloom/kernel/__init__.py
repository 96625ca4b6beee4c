"""hexloom.kernel"""
