"""hexloom.operators"""
