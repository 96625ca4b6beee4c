"""hexloom.sources"""
