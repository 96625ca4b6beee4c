"""hexloom.streaming"""
