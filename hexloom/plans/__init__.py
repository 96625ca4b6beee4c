"""hexloom.plans"""
